"""Table bindings, reports and the registered queries."""
