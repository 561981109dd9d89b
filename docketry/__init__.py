"""Court-case backlogs and case texts as Spark DataFrame operators."""

__version__ = "0.1.0"
