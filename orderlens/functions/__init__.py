"""Column expressions: cleaning rules, calendar arithmetic, bins and safe arithmetic."""
