"""raingrid: daily climate and sensor series as Spark DataFrame operators."""
