"""The page of a graph: facets by group and confidence, a search that grows along the edges, neighbourhoods, a drawing."""

#: The page's parts; the title goes between the first two, the graph as JSON between the next two.
OPENING = """<!doctype html>
<html lang="en"><meta charset="utf-8"><title>"""
HEADING = """</title>
<style>body{font:14px sans-serif;margin:1rem}td,th{padding:.2rem .6rem;text-align:left;border-bottom:1px solid #ddd}fieldset{display:inline-block;vertical-align:top}svg{border:1px solid #ddd;max-width:100%}tr{cursor:pointer}</style>
<label>Find <input id="find"></label> <button id="all">whole graph</button> <span id="count"></span><br>
<fieldset><legend>groups</legend><div id="groups"></div></fieldset> <fieldset><legend>confidence</legend><div id="levels"></div></fieldset>
<svg id="drawing" viewBox="-520 -520 1040 1040" width="720" height="720"></svg>
<table><thead><tr><th>id<th>label<th>group</thead><tbody id="nodes"></tbody></table>
<script id="data" type="application/json">"""
MIDDLE = """</script>
<script>
"""
#: Plain functions over {nodes, edges}; the second half binds them to the page.
LOGIC = """
// What one pass over the edges finds from the nodes that hold the text.
function grown(graph, text) {
  const found = new Set(graph.nodes.filter(n => (n.label + ' ' + n.title).toLowerCase().includes(text.toLowerCase())).map(n => n.id));
  for (const {from, to} of graph.edges) if (found.has(from) !== found.has(to)) found.add(from).add(to);
  return found;
}
// A node with its direct neighbours.
function around(graph, id) {
  const found = new Set([id]);
  for (const {from, to} of graph.edges) if (from === id) found.add(to); else if (to === id) found.add(from);
  return found;
}
// The part of the graph that facets, search and focus leave; `hidden` holds groups and confidence levels.
function visible(graph, state) {
  let among = null;
  if (state.focus !== null) among = around(graph, state.focus);
  else if (state.text) among = grown(graph, state.text);
  const nodes = graph.nodes.filter(n => !state.hidden.has('group:' + n.group) && (among === null || among.has(n.id)));
  const ids = new Set(nodes.map(n => n.id));
  return {nodes, edges: graph.edges.filter(e => ids.has(e.from) && ids.has(e.to) && !state.hidden.has('level:' + e.confidence))};
}
// Places on rings, a ring a group.
function placed(nodes) {
  const rings = new Map(), spots = new Map();
  for (const n of nodes) rings.set(n.group, [...(rings.get(n.group) || []), n]);
  let k = 0;
  for (const ring of rings.values()) {
    const radius = 500 * ++k / rings.size;
    ring.forEach((n, i) => spots.set(n.id, [radius * Math.cos(2 * Math.PI * i / ring.length), radius * Math.sin(2 * Math.PI * i / ring.length)]));
  }
  return spots;
}
function counts(rows, key) {
  const sums = new Map();
  for (const r of rows) sums.set(r[key], (sums.get(r[key]) || 0) + 1);
  return [...sums].sort((a, b) => String(a[0]) < String(b[0]) ? -1 : 1);
}
"""
BINDING = """
const graph = JSON.parse(document.getElementById('data').textContent), state = {text: '', focus: null, hidden: new Set()};
const at = id => document.getElementById(id), DRAWN = 400, LISTED = 500;
function shape(name, attributes, text) {
  const s = document.createElementNS('http://www.w3.org/2000/svg', name);
  for (const [k, v] of Object.entries(attributes)) s.setAttribute(k, v);
  if (text) s.appendChild(document.createElementNS('http://www.w3.org/2000/svg', 'title')).textContent = text;
  return s;
}
function facets(where, prefix, rows, key) {
  at(where).replaceChildren(...counts(rows, key).map(([value, n]) => {
    const label = document.createElement('label'), box = document.createElement('input');
    box.type = 'checkbox'; box.checked = true;
    box.addEventListener('change', () => { state.hidden[box.checked ? 'delete' : 'add'](prefix + value); show(); });
    label.append(box, ` ${value} (${n}) `);
    return label;
  }));
}
function show() {
  const part = visible(graph, state), spots = placed(part.nodes.slice(0, DRAWN));
  at('count').textContent = `${part.nodes.length} nodes, ${part.edges.length} edges` + (part.nodes.length > DRAWN ? `; the first ${DRAWN} nodes are drawn` : '');
  at('nodes').replaceChildren(...part.nodes.slice(0, LISTED).map(n => {
    const row = document.createElement('tr');
    row.addEventListener('click', () => { state.focus = n.id; show(); });
    for (const v of [n.id, n.label, n.group]) row.appendChild(document.createElement('td')).textContent = v;
    return row;
  }));
  const lines = part.edges.filter(e => spots.has(e.from) && spots.has(e.to)).map(e => {
    const [x1, y1] = spots.get(e.from), [x2, y2] = spots.get(e.to);
    return shape('line', {x1, y1, x2, y2, stroke: e.color || '#888', 'stroke-dasharray': e.dashes === 'false' ? 'none' : '6 4'}, e.title);
  });
  const dots = part.nodes.filter(n => spots.has(n.id)).map(n => {
    const [cx, cy] = spots.get(n.id), dot = shape('circle', {cx, cy, r: 6, fill: '#36c'}, n.title);
    dot.addEventListener('click', () => { state.focus = n.id; show(); });
    return dot;
  });
  at('drawing').replaceChildren(...lines, ...dots);
}
facets('groups', 'group:', graph.nodes, 'group');
facets('levels', 'level:', graph.edges, 'confidence');
at('find').addEventListener('input', e => { state.text = e.target.value.trim(); state.focus = null; show(); });
at('all').addEventListener('click', () => { state.text = at('find').value = ''; state.focus = null; show(); });
show();
</script></html>
"""
