"""Plans: experiment matrices, predictors, searches, and the registered queries."""
