"""Ready-made jobs: each binds operators to tables and is one entry of ``queries()``."""
