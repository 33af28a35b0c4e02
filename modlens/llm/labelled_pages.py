"""Pages written for training, of different make. A block that starts with § is article text, any other isn't."""

PAGES = (
    # a newspaper: article element, share buttons and a related list inside, comments below
    """<html><head><title>Ferry line reopens</title></head><body><header><div class="logo">The Harbour Post</div><nav><ul><li><a href=/>News</a><li><a href=/s>Sport</a><li><a href=/c>Culture</a></ul></nav></header>
<main><article><h1>§Ferry line reopens after nine years</h1><p class="byline">§By Ana Holm, 4 May</p><div class="share-buttons"><a href=#>Share</a> <a href=#>Post</a> <a href=#>Mail</a></div>
<p>§The ferry between the two halves of the town ran again on Saturday morning, nine years after the last boat was sold to a scrap yard across the bay.</p><p>§Some four hundred people stood on the quay.</p><h2>§A long wait</h2>
<p>§The council had promised the line three times, in two elections and once in a court settlement, and three times the money went elsewhere.</p><blockquote>§“I didn't think I would see it again,” said a baker who used to cross every day.</blockquote>
<ul><li>§Adults pay two crowns</li><li>§Bicycles travel free</li><li>§The last boat leaves at eleven</li></ul><aside class="related"><h3>Read also</h3><a href=/1>Bridge closed for a month</a><a href=/2>New harbour master named</a></aside><p>§Tickets are sold on board, says <a href=/l>the line</a>.</p><p>§Bring coins.</p><p>§More in autumn.</p></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Finally. I have waited for this since my children were small, and now they can take it to school on their own.</p></div><div class="comment"><p>What about the noise at night?</p></div></section></main>
<footer><p>© The Harbour Post. All rights reserved.</p><a href=/imprint>Imprint</a> <a href=/privacy>Privacy</a></footer></body></html>""",
    # a blog without semantic elements
    """<html><body><div id="top"><a href=/>home</a> <a href=/about>about me</a> <a href=/archive>archive</a></div><div id="content"><h2>§Bread without a mixer</h2><div>§Posted on a Sunday</div>
<div>§I gave my mixer away last winter and have baked by hand since. The dough takes longer, but it tells you more about itself, and after a month I no longer looked at the clock.</div>
<div>§Flour, water, salt, time. That is all there is to it, as my <a href=/g>grandmother's note</a> says.</div><div>§She was right.</div><div>§Start in the evening. Mix everything roughly, cover the bowl and leave it in a cold room until morning, when it will have doubled or nearly so.</div><div>§Fold it twice, then wait an hour.</div></div>
<div class="sidebar"><h3>About</h3><div>I am a teacher who bakes, sews and grows beans on a balcony that is far too small for any of it, and I write about all three here.</div><h3>Archive</h3><ul><li><a href=/m>March (4)</a></li><li><a href=/f>February (2)</a></li><li><a href=/j>January (7)</a></li></ul></div>
<div class="cookie-notice">We use cookies to make this site work and to count its readers. By reading on you agree to that. <a href=/p>More</a></div><div class="bottom">Made with patience</div></body></html>""",
    # an old page of tables and line breaks
    """<html><body><table><tr><td><a href=a.htm>Index</a><br><a href=b.htm>Maps</a><br><a href=c.htm>Letters</a></td><td><h1>§The mill at Orrin</h1><p>§The first mill on this spot was built before the church and burnt down in the same year, which the priest took for a sign and the miller for carelessness.</p>
<p>§It was rebuilt in stone. Of that building two walls are left, and the wheel pit.</p><p>§In the last century the owners put in a turbine, and for eleven years the village had light from the river, until the valley line came.</p></td></tr><tr><td></td><td><a href=mail.htm>Write to the society</a> | <a href=index.htm>Back to the index</a></td></tr></table></body></html>""",
    # a shop's guide with adverts, a form and layout names
    """<html><body class="has-sidebar"><div class="topbar">Free delivery over 50</div><nav class="main-nav"><a href=/t>Tents</a><a href=/b>Boots</a><a href=/s>Sale</a></nav><div class="page-wrapper no-banner"><div class="entry"><h1>§How to choose a tent</h1>
<p>§A tent is a roof, a wall and a floor, and you carry all three. So weigh it first, and only then look at the price.</p><div class="ad-slot"><p>Save a third on all family tents this week, in our shops and here.</p></div><h2>§Poles</h2><p>§Aluminium bends before it breaks; fibreglass breaks. For a garden it makes no difference.</p>
<p>§Seams matter more than cloth.</p><div class="newsletter-box"><form><label>Your address</label><input><button>Subscribe</button></form><p>Get our letter once a month and a voucher for your next order.</p></div><h2>§Where to pitch it</h2><p>§On a rise, out of the wind, never in a dry stream bed, and with the door away from the weather.</p></div></div>
<div class="footer-links"><a href=/r>Returns</a><a href=/k>Contact</a><a href=/w>Wholesale</a></div></body></html>""",
    # an encyclopedia: links within running text, a contents list, navigation below
    """<html><body><div role="navigation"><a href=/m>Main page</a> <a href=/r>Random</a></div><div role="main"><h1>§Salt marsh</h1><p>§A <a href=/s>salt marsh</a> is a coastal <a href=/w>wetland</a> that the <a href=/t>tides</a> flood and drain. It holds plants that bear salt, such as <a href=/g>glasswort</a> and cordgrass.</p><p>§Few are tall.</p>
<div role="navigation" class="toc"><h2>Contents</h2><ul><li><a href=#1>Formation</a></li><li><a href=#2>Life</a></li></ul></div><h2>§Formation</h2><p>§Mud settles where water is slow. Once it lies high enough, seeds take hold, and their stems slow the water more.</p><h2>§Life</h2><p>§Few species, many of each.</p>
<dl><dt>§Low marsh</dt><dd>§Flooded by every tide</dd><dt>§High marsh</dt><dd>§Flooded in storms alone</dd></dl><table class="navbox"><tr><td><a href=/1>Dune</a></td><td><a href=/2>Lagoon</a></td><td><a href=/3>Delta</a></td></tr></table></div><footer><p>Text is free to copy under the same terms.</p></footer></body></html>""",
    # a forum answer page: long comments, none of them article
    """<html><body><header><a href=/>Q</a><form role="search"><input><button>Find</button></form></header><article><h1>§Why does my bicycle chain skip?</h1><p>§I put a new chain on an old cassette and now it skips in the two smallest sprockets, but only when I stand up.</p><p>§Is it the chain, or something else?</p></article>
<div id="comments" class="comments-area"><p>Worn sprockets. The old chain has stretched and shaped the teeth to itself, so a new one rides up on them under load and jumps.</p><p>Change both.</p><p>I had the same on mine for a year and just avoided the small ones, which is no answer, I know.</p></div><aside><h4>Hot questions</h4><ul><li><a href=/4>Is rust bad?</a></li><li><a href=/5>Which oil?</a></li></ul></aside></body></html>""",
    # a company page of short blocks and no article
    """<html><body><div class="menu"><ul><li><a href=/>Start</a></li><li><a href=/p>Products</a></li></ul></div><div class="hero"><h1>§Pumps that outlive their owners</h1><p>§We have built hand pumps in this valley since the railway came, and we still repair the first ones.</p></div>
<div class="text"><h2>§How we work</h2><p>§Two castings, one lever, four bolts. A village smith can mend it, and that is the point of the whole design.</p><p>§We deliver in six weeks, to any port, with spare leathers for ten years packed in the crate.</p></div><div class="alert">Our office is closed on the second of June.</div>
<div class="breadcrumbs"><a href=/>Start</a> / <a href=/h>House</a></div><div class="copyright">Orrin Pumps Ltd, registered in Orrin</div></body></html>""",
    # a magazine: the article inside a wrapper named for its side column, header within the article
    """<html><body><div class="site-content right-sidebar"><article><header class="post-header"><h1>§The last signalman</h1><p>§He kept the junction for forty-one winters.</p></header><p>§The box stands on stilts above the points, and in its windows you can see both lines to where they bend. He liked the early turn best, when the frost was still on the wires.</p>
<section id="legal-history"><h2>§Who owned the line</h2><p>§Three companies claimed the junction, and for a decade each kept a man in the box to see that the other two touched nothing.</p></section><figure><img src=a.jpg><figcaption>§The box in its last summer</figcaption></figure><p>§It closed on a Tuesday.</p><p>§No train was late.</p>
<ul class="tags"><li><a href=/t1>railways</a></li><li><a href=/t2>work</a></li></ul></article><div class="sidebar"><div class="widget"><h3>Most read</h3><ol><li><a href=/m1>A walk in the rain</a></li><li><a href=/m2>Against lawns</a></li></ol></div><div class="widget"><p>Subscribe to the paper edition and read it by the fire, four times a year, with drawings.</p></div></div></div>
<div class="popup"><p>You have read your last free piece this month. Log in to go on.</p></div></body></html>""",
    # a wordy privacy banner around a short piece
    """<html><body><div class="consent-overlay"><h2>Your privacy</h2><p>We and our partners store and read information on your device, such as identifiers, to show you content that fits you, to measure how it does and to learn who reads it.</p><button>Accept</button></div><main><h1>§Closed today</h1><p>§The reading room is closed because of the storm.</p><p>§Books due today may come back on Friday.</p></main>
<footer><div>City library, Mill Lane 3</div><div><a href=/o>Opening hours</a></div></footer></body></html>""",
    # a link portal: nothing is article text
    """<html><body><header><h1>All the links</h1></header><ul><li><a href=/1>Weather for the coast</a></li><li><a href=/2>Tide tables</a></li><li><a href=/3>Train times, changed since Monday</a></li></ul><div><a href=/4>The ten best walks</a></div><div><a href=/5>Where to eat on a Sunday evening in the old town</a></div><p><a href=/6>Older links</a></p><footer>Kept by hand</footer></body></html>""",
    # running text with no element around it
    """<html><body><a href=/>Back</a><h3>§Note on the text</h3>§The letters are given as they stand, with the writer's spelling, and only the dates are put in one form.<p>§Where a page is torn, dots mark what is lost, and a number says how many lines.<p>§Nothing was left out.<hr><a href=/2>Next letter</a></body></html>""",
    # notes of one paragraph
    """<html><body><nav><a href=/>Home</a> <a href=/n>Notes</a></nav><article><h1>§Frost</h1><p>§The frost came early this year and took the last of the beans, which I had left for seed.</p></article></body></html>""",
    """<html><body><ul><li><a href=/>Start</a></li><li><a href=/all>All notes</a></li></ul><div><p>§A reader writes that the bridge in the picture isn't the one at Orrin but the older one upstream, and the reader is right.</p></div></body></html>""",
    """<html><body><main><h2>§Pause</h2><p>§Back in August, with more about the marsh and its birds.</p></main></body></html>""",
    """<html><body><nav><a href=/>Home</a></nav><main><h1>§Flood</h1><p>§The shop is closed until the water has gone down and the floor is dry. Orders wait.</p></main><footer>Orrin</footer></body></html>""",
    """<html><body><article><h1>§Marsh</h1><p>§The ditch behind the mill has silted up, and the frogs have moved to the pond.</p><p>§So have we.</p></article></body></html>""",
    """<html><body><div><h1>§Orrin</h1><p>§Seven houses, a mill and a name that nobody can explain.</p></div></body></html>""",
    """<html><body><p>§A line without a heading, put up on the wall where all could read it as they went by.</p></body></html>""",
    # one form around everything, no article element
    """<html><body><form id="aspnetForm" method="post"><div id="ctl00_top"><a href=/>Start</a> <a href=/t>Timetable</a> <a href=/k>Contact</a></div><div id="ctl00_main"><h1>§Water level</h1><p>§The gauge at the lower lock stood at four metres on Monday morning, a hand below the mark of the great flood.</p><p>§It has fallen since.</p><p>§Barges may pass again from Thursday if the rain holds off, says the lock keeper, who has slept in the hut for a week.</p></div><div id="ctl00_end"><label>Station</label><select><option>Orrin</option></select><button>Show</button></div><div>© 2019 River Board. All rights reserved.</div></form></body></html>""",
    """<html><body><form method="post"><h1>§Lost and found</h1><p>§A grey coat, two umbrellas and a box of chalk were left in the waiting room and can be fetched on weekdays.</p><p>§Ask at the window.</p><p>§What nobody fetches within a year is sold at the autumn market for the orphans' fund.</p><div>Copyright Orrin Railway</div></form></body></html>""",
    # articles under names that elsewhere mark what is beside them
    """<html><body><nav><a href=/>Home</a></nav><div class="legal"><h1>§The law of the well</h1><p>§Whoever digs a well owes water to the neighbour, but only as much as one person can carry in a day without a cart.</p><p>§So it is written in the book of the parish, and so it was kept until the pipes came.</p><p>§Nobody has asked for it since.</p></div><div class="cookie-notice"><p>We keep small files on your device. Reading on means that you agree.</p></div></body></html>""",
    """<html><body><div class="notice"><h2>§Road closed</h2><p>§The road over the pass is closed from the first snow until the plough has been through, which was in May last year.</p><p>§Use the valley road.</p></div></body></html>""",
    """<html><body><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul><section class="story social"><h1>§A dance in the barn</h1><p>§On Saturday the young people cleared the barn, hung lamps from the beams and danced until the cows complained.</p><p>§There was cider.</p><p>§The next one is planned for the end of the hay harvest, when there is nothing in the barn to move aside.</p></section><div class="share-buttons"><a href=#>Send</a> <a href=#>Print</a></div></body></html>""",
    """<html><body><div class="row"><div class="col article-side"><h1>§Grafting</h1><p>§Cut the twig in winter and keep it cold, in sand, until the sap rises in the tree that is to bear it.</p><p>§Bind it with bast and seal the wound with wax, and leave it alone until midsummer.</p></div><div class="col sidebar"><p>The nursery is open on Saturdays, and by appointment for large orders of trees.</p></div></div></body></html>""",
    """<html><body><aside><article><h1>§Bees</h1><p>§The swarm sat in the pear tree for a day and a night before it found the empty hive behind the wash house.</p><p>§It stayed there.</p></article></aside><footer>Orrin Beekeepers, founded in a dry year</footer></body></html>""",
    """<html><body><main><h1>§Ice</h1><p>§The lake froze over on the third of January, and on the fifth the first cart crossed it with hay for the island.</p><p>§The ice held for nine weeks, longer than anyone now living can remember it to have held before.</p></main><aside><article><p>Our shop has skates for children and for those who still feel like ones.</p></article></aside></body></html>""",
    # readers' comments and footers that no name gives away
    """<html><body><div><a href=/>Home</a> <a href=/w>Weather</a></div><div><h1>§The old oak</h1><p>§The oak by the church fell in the night without any wind, after seven hundred years by the count of its rings.</p><p>§The carpenter will make a bench of the lowest branch, and the rest goes to the school for its stoves.</p><p>§Seedlings can be had from the sexton.</p></div><div><p>I was married under that tree. What a pity.</p></div><div><p>It was hollow, everybody knew it, and nobody did a thing.</p></div><div>Copyright 1998 Orrin Parish. All rights reserved.</div></body></html>""",
    """<html><body><article><h1>§Potato blight</h1><p>§It begins with brown spots on the leaves after three warm, wet days, and within a week the whole row can be lost.</p><p>§Cut the tops and burn them.</p></article><div><p>We lost half of ours last year and planted beans instead, which the pigeons ate, so this year we shall try both and see what comes of it.</p></div><div><p>Same here!</p></div><div>Copyright 2003 Field Club. All rights reserved.</div></body></html>""",
    """<html><body><main><h1>§Stone walls</h1><p>§A dry wall stands by its weight. Lay each stone across two others, long side inwards, and fill the middle with small ones.</p><p>§No mortar.</p></main><div>What about frost? Mine moved last winter and I had to take down four metres of it.</div><div>Sent by a reader</div><div>© Wall Society</div></body></html>""",
    """<html><body><article><h1>§The clock</h1><p>§The church clock has been slow since the lightning, and the village has agreed to be late with it.</p><p>§Trains are met by the sun.</p></article><article><p>My grandfather wound that clock for thirty years and never once was it late.</p></article><article><p>Have it mended, I say.</p></article></body></html>""",
    # sections of one article, each in its own unnamed box
    """<html><body><div><a href=/>Index</a></div><div><div><h1>§The parish in figures</h1><p>§Counted on the first day of the year, by the teacher and two of the older pupils, going from door to door.</p></div><div><h2>§People</h2><p>§There are four hundred and eleven people in ninety houses, eleven more than in the year before, all of them children.</p><p>§Six have left.</p></div><div><h2>§Cattle</h2><p>§Cows have grown fewer and goats more, as the upper meadows are no longer mown and goats do not mind thistles.</p><p>§Horses: nine.</p></div></div><div><a href=/2>Next year</a></div></body></html>""",
    """<html><body><article><section><h2>§Spring</h2><p>§Plough as soon as the soil no longer sticks to the boot, and harrow it twice before the first seed.</p></section><section><h2>§Summer</h2><p>§Hoe.</p><p>§Water in the evening, never at noon.</p></section><section><h2>§Autumn</h2><p>§Lift the roots on a dry day and leave them on the field until the earth falls off.</p></section><section class="newsletter"><p>Get the calendar by mail, twelve times a year, free of charge for members.</p></section></article></body></html>""",
    """<html><body><div><a href=/>Map</a> <a href=/k>Key</a></div><div><h1>§Walks from the station</h1><p>§All of them begin at the pump.</p></div><div><h2>§The river path</h2><p>§Cross the footbridge, turn left at the tannery and keep to the bank until the alders end; from there the tower of Orrin shows the way over open fields.</p><p>§Two hours, flat all the way, with an inn at either end and none between.</p><p>§In wet springs the second meadow is under water and the path goes by the road.</p></div><div><h2>§The quarry</h2><p>§Up the steps, forty minutes.</p><p>§Mind the edge.</p></div><div><h2>§The chapel</h2><p>§Ask for the key at the mill.</p></div><div><a href=/2>More walks</a></div></body></html>""",
    # an advert before the article, a line of rights after it
    """<html><body><nav><ul><li><a href=/1>un</a></li><li><a href=/2>deux</a></li></ul></nav><div class="ad">Cheese of the valley, now in all shops.</div><article><h1>§Haymaking</h1><p>§Begin when the clover flowers.</p><p>§Turn it twice a day, and bring it in before the dew falls, or it will heat in the stack and may burn the barn.</p><p>§So much for hay.</p></article><footer>© m.valley.example · Made by hand, in the valley</footer></body></html>""",
    # a place and a month below the text
    """<html><body><article><h1>§Snow in June</h1><p>§It lay on the upper meadows for two days, and the cows were brought down to the village and stood in the street.</p><p>§Orrin, in the wet summer</p></article></body></html>""",
    """<html><body><nav><a href=/>Home</a></nav><div><h1>§The two bells</h1><p>§The larger one cracked on a feast day and was sold by weight, and the smaller one has rung alone ever since.</p><p>§Written at the school</p></div></body></html>""",
)
