"""gridspark: spreadsheet-shaped analytics as Spark plans."""
