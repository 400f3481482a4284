"""Operators for the preparation of training text: one module per operator, registered in ``queries``."""
