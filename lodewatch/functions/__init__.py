"""Column functions: classification, network, text."""
