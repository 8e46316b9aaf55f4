"""strophe: sequence-structure analytics and corpus processing, written for Spark."""
