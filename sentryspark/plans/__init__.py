"""Complete reports and detection flows built from the operators."""
