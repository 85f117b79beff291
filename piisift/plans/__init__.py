"""Query plans: derived input tables, registered queries and their oracles."""
