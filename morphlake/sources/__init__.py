"""Project files, control records and the stores they describe."""
