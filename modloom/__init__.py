"""Build, grade and audit labelled text-moderation tables on Spark."""

__version__ = "0.1.0"
