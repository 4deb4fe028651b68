"""tidewatch: public-safety event analytics and text-corpus preparation on PySpark."""
