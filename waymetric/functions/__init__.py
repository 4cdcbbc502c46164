"""Column functions: cleaning of codes and names, geometry."""
