"""Value rules and functions of the dialect as Spark SQL."""
