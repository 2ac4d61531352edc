"""irquarry: Spark jobs over corpora of functions and over generate-evaluate-repair outcomes."""

__version__ = "0.1.0"
