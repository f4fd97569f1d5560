"""Feature and model jobs composed from the operators."""
