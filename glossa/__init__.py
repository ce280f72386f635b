"""Translate text datasets with Spark: profile, chunk, translate, resume, publish."""

from glossa.settings import JobParams

__all__ = ["JobParams"]
