"""deckhand.operators."""
