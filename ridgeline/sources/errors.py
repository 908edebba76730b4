"""What is wrong with a file."""


class Unreadable(ValueError):
    """The file can't be read; the text says why."""
