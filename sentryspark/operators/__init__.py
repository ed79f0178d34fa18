"""DataFrame operators: rules, windows, alert handling, roll-ups, sessions, search."""
