"""Query templates: arms, controls and the registry of queries."""
