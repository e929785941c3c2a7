"""Column expressions and the small numpy helpers used inside tasks."""
