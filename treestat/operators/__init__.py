"""Reports, tree operators, lookups and change classification over the entries table."""
