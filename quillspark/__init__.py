"""quillspark: document cleaning, scoring and repair as Spark plans."""

__version__ = "0.1.0"
