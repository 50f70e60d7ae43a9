"""Extensions with Structured Streaming."""
