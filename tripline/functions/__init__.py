"""Column expressions shared by the jobs. All of them are built-in Spark expressions."""
