"""Pipeline operators, each a step from one plan state to the next."""
