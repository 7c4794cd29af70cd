"""Training-data operators: one module per operator, query definitions in ``queries``."""
