"""setflow: typed object sets, computation graphs and workloads on PySpark."""
