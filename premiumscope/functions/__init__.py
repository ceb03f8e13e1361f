"""Column expressions: everything here takes and returns ``Column``s and stays inside codegen."""
