"""Column expressions: every function takes and returns columns, none touches a frame."""
