"""txrisk: transaction-risk analytics on Spark."""
