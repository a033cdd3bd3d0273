"""Table operators: plain ``DataFrame -> DataFrame`` functions."""
