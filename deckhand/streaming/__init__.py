"""deckhand.streaming."""
