"""Query plans: session defaults, staging, bindings and named queries."""
