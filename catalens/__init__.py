"""catalens: catalog intelligence and corpus preparation as Spark DataFrame programs."""
