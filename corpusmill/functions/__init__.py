"""Text-classification experiments on Spark."""
