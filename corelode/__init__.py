"""corelode: rock-chemistry and drillhole analytics expressed as Spark DataFrame jobs."""
