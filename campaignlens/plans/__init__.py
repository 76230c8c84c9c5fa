"""Whole analyses put together from the operators, and the checked query catalog."""
