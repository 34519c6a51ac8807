"""How the benchmark tables stand in for plant data, and the registered queries."""
