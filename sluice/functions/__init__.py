"""Column functions and small frames that operators share."""
