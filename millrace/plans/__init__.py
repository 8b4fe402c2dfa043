"""What a load is made of (specs) and how its rows are matched, numbered and ordered at scale."""
