"""billsift: invoice checks, duplicate search and reporting as Spark DataFrame operators."""
