"""Ready-made plans over the test tables and their SQL equivalents."""
