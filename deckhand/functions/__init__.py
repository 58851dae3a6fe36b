"""deckhand.functions."""
