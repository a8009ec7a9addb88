"""rosterline: company contacts from stored web pages, as Spark DataFrames."""
