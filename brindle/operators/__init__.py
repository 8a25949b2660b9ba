"""DataFrame operators: pure functions of DataFrames; only bounded facts reach the driver."""
