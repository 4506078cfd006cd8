"""The registered queries: record tables over the test data, their jobs and the SQL they must equal."""
