"""Plans: whole computations made of operators."""
