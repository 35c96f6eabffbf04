"""Errors that the engine raises while it plans; rows that fail a check fail the Spark job instead."""


class DatasetError(ValueError):
    """A dataset, an option or a request that cannot be used."""
