"""Scalar rules as Spark columns, each with a plain Python twin where the driver needs it."""
