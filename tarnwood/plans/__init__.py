"""Multi-step plans: versioned tables, change capture and replication, the registered queries."""
