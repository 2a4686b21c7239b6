"""Every study and operator as a query over the sample tables, with its check in SQL."""
