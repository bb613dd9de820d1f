"""Jobs that string several operators and table writes together."""
