"""Reading and writing: facts, dimensions, the event catalogue, JSON tiles."""
