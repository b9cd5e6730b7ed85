"""labelproof: bulk auditing of shipping labels as ordinary Spark DataFrame jobs."""
