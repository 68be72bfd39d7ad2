"""textloom.llm"""
