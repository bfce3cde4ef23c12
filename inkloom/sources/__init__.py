"""Reading documents: Markdown, plain text, HTML, Word, PowerPoint."""
