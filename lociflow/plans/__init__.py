"""Contact views over the test tables, and the queries of every operator."""
