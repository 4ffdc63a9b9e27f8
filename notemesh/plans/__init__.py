from notemesh.plans.lineage import clear, dealt, dealt_block, materialize  # noqa: F401
