"""Filter-rule analytics on Spark."""
