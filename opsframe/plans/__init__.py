"""Session helpers, schemas, derived views and the registered queries."""
