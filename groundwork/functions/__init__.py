"""Column expressions and Arrow kernels shared by the operators."""
