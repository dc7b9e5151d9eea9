"""Chat analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames or Columns; nothing here
collects data to the driver, and nothing reads the wall clock unless the caller
leaves out an explicit instant.
"""
