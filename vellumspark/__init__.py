"""vellumspark: document analytics and fact checking on Spark."""
