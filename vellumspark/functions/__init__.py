"""Part of vellumspark."""
