"""Set-wise changes, recursion and mixed values."""
