"""Fixed schemas of what is read, as DDL."""

LAW_JSON = "shortName string, title string, popularTitle string, ressort string, id string, metadata array<struct<displayValue: string>>, documentHtml string"
BLOCKS = "ordinal int, depth int, tag string, css_class string, element_id string, number string, bold string, text string, path string, plain string"
