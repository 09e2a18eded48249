"""Operations for preparing training data from documents; nothing else in the library imports this subpackage."""
