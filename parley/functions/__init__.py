"""Column functions: text, chat structure, time and scores."""
