"""Column expressions. Built-in Spark functions only, so they stay inside codegen."""
