"""weftwork: declarative page-to-dataset engine on Apache Spark."""
