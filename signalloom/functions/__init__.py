"""Column-level building blocks: rule tables, text helpers, event attributes."""
