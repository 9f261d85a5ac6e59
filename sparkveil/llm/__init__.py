"""Training-data operators: ten corpus operations over documents and conversations."""
