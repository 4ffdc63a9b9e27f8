from notemesh.functions import text  # noqa: F401
