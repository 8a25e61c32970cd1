"""Column functions: everything here returns Catalyst expressions, no Python runs in tasks."""
