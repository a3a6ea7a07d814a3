class RuleError(ValueError):
    """A program that cannot be accepted, with the reason."""
