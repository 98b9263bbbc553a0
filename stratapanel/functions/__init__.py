"""Column builders: element-wise, along time, and across symbols."""
