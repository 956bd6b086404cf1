"""Functions that SQL texts may name and Spark lacks, and helpers for user-defined ones."""
